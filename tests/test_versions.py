"""Versions of saved tables: one commit for all, clustered storage, parts that keep their files."""

import datetime as dt

import pytest
from pyspark.sql import DataFrame, functions as F

from newstide import NewsEngine, schemas
from newstide.operators import corpus
from newstide.plans import refresh
from newstide.sources import prices as px, snapshots, versions

D = dt.date


def prices_of(spark, symbols, days=6, value=1.0):
    rows = [(s, D(2024, 1, d), value * d, 2.0 * d, 0.5 * d, value * d + d % 3, d)
            for s in symbols for d in range(1, days + 1)]
    return spark.createDataFrame(rows, schemas.PRICES)


def articles_of(spark, symbols, days=5, text="x"):
    rows = [(s, dt.datetime(2024, 1, d), D(2024, 1, d), "t", f"l{d}", ("h", "H"), str(d), text,
             10 * d, None if d == 4 else 15 * d) for s in symbols for d in range(1, days + 1)]
    return spark.createDataFrame(rows, schemas.ARTICLES)


def engine_of(spark, symbols=("A", "B", "C"), text="x", **more):
    dimension = px.symbol_dimension(spark, {"i": symbols[:2], "j": symbols[2:]})
    return NewsEngine(dimension, prices_of(spark, symbols), articles_of(spark, symbols, text=text),
                      **more)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_a_save_that_stops_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    engine_of(spark).save(root)
    before = {name: rows(getattr(snapshots.load_all(spark, root), name))
              for name in ("articles", "links", "prices", "days", "timeline")}
    written = []
    for method in ("write", "write_clustered"):
        def stopping(self, name, *args, _whole=getattr(versions.Draft, method), **more):
            if len(written) == 3:
                raise InterruptedError(name)
            written.append(name)
            _whole(self, name, *args, **more)
        monkeypatch.setattr(versions.Draft, method, stopping)
    with pytest.raises(InterruptedError):
        engine_of(spark, text="changed").save(root)
    assert len(written) == 3
    load = snapshots.load_all(spark, root)
    assert {name: rows(getattr(load, name)) for name in before} == before
    monkeypatch.undo()
    engine_of(spark, text="changed").save(root)
    load = snapshots.load_all(spark, root)
    assert {r.text for r in load.articles.collect()} == {"changed"}
    # what the stopped save left goes with the old versions
    assert versions.remove_old_versions(spark, root) == [1]
    assert len(list((tmp_path / versions.DATA).iterdir())) == 1
    assert rows(snapshots.load_all(spark, root).prices) == before["prices"]


def test_readers_stay_with_their_version(spark, tmp_path):
    root = str(tmp_path)
    engine_of(spark).save(root)
    load = snapshots.load_all(spark, root)
    engine_of(spark, symbols=("A", "B"), text="new").save(root, layout="symbol")
    assert {r.text for r in load.articles.collect()} == {"x"} and load.days.count() == 18
    again = snapshots.load_all(spark, root)
    # the symbols of the second save are replaced, the third stays
    assert {(r.symbol, r.text) for r in again.articles.collect()} == {("A", "new"), ("B", "new"),
                                                                      ("C", "x")}
    assert again.days.count() == 18 and again.prices.count() == 18
    assert rows(snapshots.load_all(spark, root, 1).articles) == rows(load.articles)
    with pytest.raises(ValueError):
        versions.remove_old_versions(spark, root, keep=0)


def test_the_first_of_two_commits_wins(spark, tmp_path):
    root = str(tmp_path)
    engine_of(spark).save(root)
    with pytest.raises(versions.CommitConflict):
        with versions.new_version(spark, root) as draft:
            engine_of(spark, text="first").save(root)
            draft.write("articles", articles_of(spark, ["A"], text="second"))
    assert {r.text for r in snapshots.load_all(spark, root).articles.collect()} == {"first"}
    assert versions.versions(spark, root) == [1, 2]
    with pytest.raises(ValueError, match="stored by symbol, |write it"):
        with versions.new_version(spark, root) as draft:
            draft.write("articles", articles_of(spark, ["A"]), "bucket")
            draft.write("articles", articles_of(spark, ["B"]), "symbol")
    assert versions.versions(spark, root) == [1, 2]


def symbol_exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "hashpartitioning(symbol" in line]


@pytest.mark.parametrize("layout", ["symbol", "bucket"])
def test_a_loaded_engine_shuffles_nothing_by_symbol(spark, tmp_path, layout):
    root = str(tmp_path)
    engine = engine_of(spark)
    engine.save(root, layout)
    loaded = NewsEngine.load(spark, root, engine.symbols)
    for report in (lambda e: e.score_and_predict(windows=[3, 7]), lambda e: e.analyze_accuracy(),
                   lambda e: e.analyze_cov(), lambda e: e.timeline()):
        found = report(loaded)
        assert symbol_exchanges(found) == []
        assert rows(found) == rows(report(engine))
    # the symbols' own reports meet their industry in a broadcast join
    assert symbol_exchanges(loaded.analyze_sweep([3, 7])) == []
    assert rows(loaded.analyze_sweep([3, 7])) == rows(engine.analyze_sweep([3, 7]))
    plan = loaded.analyze_accuracy()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "text:" not in plan


def test_a_saved_proof_is_not_repeated(spark, tmp_path):
    engine_of(spark).save(str(tmp_path / "unique"))
    loaded = NewsEngine.load(spark, str(tmp_path / "unique"), engine_of(spark).symbols)
    assert loaded.unique and "Exchange" not in (
        loaded.articles._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", ""))
    twice = NewsEngine(engine_of(spark).symbols, prices_of(spark, "ABC"),
                       articles_of(spark, "ABC").union(articles_of(spark, "A")), duplicates="keep")
    twice.save(str(tmp_path / "twice"))
    with pytest.raises(Exception, match="duplicate key"):
        NewsEngine.load(spark, str(tmp_path / "twice"), twice.symbols).corpus_stats().collect()
    # one engine that may have copies takes the proof from the table, and keeps its own from others
    engine_of(spark, symbols=("D",)).save(str(tmp_path / "twice"))
    assert not snapshots.load_all(spark, str(tmp_path / "twice")).unique
    with pytest.raises(Exception, match="duplicate key"):
        NewsEngine(twice.symbols, twice.prices, twice.articles).save(str(tmp_path / "unique"))
    assert versions.versions(spark, str(tmp_path / "unique")) == [1]


def test_one_symbol_is_read_from_its_part(spark, tmp_path):
    root = str(tmp_path)
    engine_of(spark).save(root, "bucket")
    version = versions.version_of(spark, root)
    one = versions.read_version(spark, root, version, "articles", "B")
    assert {r.symbol for r in one.collect()} == {"B"} and one.count() == 5
    parts = {path.split("part=")[1].split("/")[0] for path in one.inputFiles()}
    assert len(parts) == 1
    assert versions.read_version(spark, root, version, "articles", "none").count() == 0
    assert versions.read_version(spark, root, version, "absent") is None
    assert versions.version_of(spark, str(tmp_path / "nothing")) is None


def test_empty_tables_and_tables_of_other_names(spark, tmp_path):
    root = str(tmp_path)
    with versions.new_version(spark, root) as draft:
        draft.write("articles", articles_of(spark, "A").limit(0))
        draft.write("notes", spark.createDataFrame([("A", 1)], "symbol STRING, n INT"))
        draft.write("plain", spark.range(3).toDF("n"))
        draft.write_clustered("prices", prices_of(spark, "A").where(F.lit(False)))
    version = versions.version_of(spark, root)
    read = {n: versions.read_version(spark, root, version, n) for n in version.tables}
    assert {n: df.count() for n, df in read.items()} == {"articles": 0, "notes": 1, "plain": 3,
                                                        "prices": 0}
    assert read["notes"].columns == ["symbol", "n"] and read["articles"].schema == schemas.ARTICLES


def delivery(spark, rows):
    """rows: (symbol, day, link, id, text); sentiments by the day"""
    full = [(s, dt.datetime(2024, 1, d), D(2024, 1, d), "t", link, ("h", "H"), i, text, d, 2 * d)
            for s, d, link, i, text in rows]
    return spark.createDataFrame(full, schemas.ARTICLES)


def test_deliveries_in_turn_equal_one_save(spark, tmp_path):
    """New links, better and worse copies of stored ones, and copies that only differ in the text."""
    first = [(s, d, f"l{d}", "m", "x") for s in "ABC" for d in (1, 2, 3)]
    second = [("A", 3, "l3", "m", "x"), ("A", 4, "l4", "m", "x"), ("B", 1, "l2", "m", "better"),
              ("B", 3, "l1", "m", "worse"), ("B", 3, "l3", "a", "better id"), ("A", 4, "l4", "m", "w")]
    third = [("A", 1, "l1", "m", "same key, other text"), ("A", 2, "l2", "m", "x")]
    dimension = px.symbol_dimension(spark, {"i": "ABC"})
    prices = prices_of(spark, "ABC")
    at_once = NewsEngine(dimension, prices, delivery(spark, first + second + third),
                         duplicates="drop")
    at_once.save(str(tmp_path / "once"))
    root = str(tmp_path / "turns")
    NewsEngine(dimension, prices, delivery(spark, first)).save(root)
    before = versions.version_of(spark, root).tables
    version, parts = refresh.merge_articles(spark, root, delivery(spark, second))
    assert parts == ["symbol_A", "symbol_B"] and version.number == 2
    for name in ("articles", "links"):  # C has no news and keeps its files
        same = {p for p, path in version.tables[name]["parts"].items()
                if path == before[name]["parts"][p]}
        assert same == {"symbol_C"}
    refresh.merge_articles(spark, root, delivery(spark, third))
    last = versions.versions(spark, root)
    # what is there already makes no version
    assert refresh.merge_articles(spark, root, delivery(spark, first + second))[1] == []
    assert versions.versions(spark, root) == last
    a, b = (snapshots.load_all(spark, str(tmp_path / name)) for name in ("once", "turns"))
    assert a.unique and b.unique
    for name in ("articles", "links", "days", "timeline", "prices"):
        assert rows(getattr(a, name)) == rows(getattr(b, name)), name
    loaded = NewsEngine.load(spark, root, dimension)
    assert rows(loaded.analyze_sweep([3])) == rows(at_once.analyze_sweep([3]))


def test_what_cannot_be_merged(spark, tmp_path):
    with pytest.raises(ValueError, match="no saved engine"):
        refresh.merge_articles(spark, str(tmp_path), articles_of(spark, "A"))
    engine_of(spark).save(str(tmp_path))
    for column in ("symbol", "link"):
        with pytest.raises(Exception, match="without a symbol or a link"):
            refresh.merge_articles(spark, str(tmp_path), articles_of(spark, "A").withColumn(
                column, F.lit(None).cast("string")))
    assert refresh.merge_articles(spark, str(tmp_path), articles_of(spark, "A").limit(0))[1] == []
    assert versions.versions(spark, str(tmp_path)) == [1]


def sources_of(spark, n_sources, n_rows, first=0):
    """A few frequent sources among many rare ones; every fourth row has no source."""
    href = F.expr(f"CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN concat('top', id % 5) "
                  f"ELSE concat('h', pmod(xxhash64(id), {n_sources})) END")
    return spark.range(first, first + n_rows).select(
        F.concat(F.lit("s"), F.col("id") % 7).alias("symbol"), F.col("id").cast("string").alias("link"),
        F.struct(F.lit("n").alias("title"), href.alias("href")).alias("source"),
        F.expr("repeat('x', CAST(id % 300 AS INT))").alias("text"))


@pytest.mark.parametrize("n_sources", [30, 3_000, 100_000])
def test_united_states_of_parts_estimate_the_whole(spark, n_sources):
    parts = [sources_of(spark, n_sources, 120_000, first) for first in (0, 120_000)]
    whole = parts[0].union(parts[1])
    states = corpus.corpus_state(parts[0]).unionByName(corpus.corpus_state(parts[1]))
    exact, got = corpus.corpus_stats(whole).first(), corpus.corpus_stats_of(states).first()
    assert (got.n_articles, got.n_with_text) == (exact.n_articles, exact.n_with_text)
    assert abs(got.n_sources - exact.n_sources) <= 0.05 * exact.n_sources
    assert got.n_sources == corpus.corpus_stats_of(corpus.corpus_state(whole)).first().n_sources
    truth = {r.href: r.n for r in corpus.top_sources(whole, 5).collect()}
    top = {r.href: r.n for r in corpus.top_sources_of(states, 5).collect()}
    assert set(top) == set(truth)
    slack = 0 if n_sources < 7_000 else 3.5 / corpus.TRACKED * exact.n_articles
    assert all(abs(top[href] - n) <= slack for href, n in truth.items())


def test_states_of_nothing(spark):
    none = sources_of(spark, 5, 0)
    assert corpus.corpus_stats_of(corpus.corpus_state(none)).first() == (0, 0, 0)
    assert corpus.top_sources_of(corpus.corpus_state(none)).count() == 0
    bare = sources_of(spark, 5, 12).withColumn("source", F.struct(
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("href")))
    assert corpus.corpus_stats_of(corpus.corpus_state(bare)).first().n_sources == 0
    assert corpus.top_sources_of(corpus.corpus_state(bare)).count() == 0


def test_stored_states_follow_saves_and_deliveries(spark, tmp_path):
    root = str(tmp_path)
    engine_of(spark, ("A", "B")).save(root)
    later = articles_of(spark, ("B", "C"), days=8, text="y" * 300).withColumn(
        "source", F.struct(F.lit("k").alias("title"), F.concat("symbol", "link").alias("href")))
    refresh.merge_articles(spark, root, later)
    dimension = px.symbol_dimension(spark, {"i": ["A", "B"], "j": ["C"]})
    for symbols in (dimension, dimension.where("symbol <> 'C'")):
        engine = NewsEngine.load(spark, root, symbols)
        assert rows(engine.corpus_stats(approximate=True)) == rows(engine.corpus_stats())
        assert rows(engine.top_sources(20, approximate=True)) == rows(engine.top_sources(20))
        # nothing of the articles is read
        files = engine.corpus_stats(approximate=True).inputFiles()
        assert files and all("/corpus/" in name for name in files)


def plans_of(monkeypatch, where, name):
    """Plans of the tables that a function writes, by their names."""
    plans, whole = {}, getattr(where, name)

    def noting(*args, **more):
        df, table = ([x for x in args if isinstance(x, kind)][0] for kind in (DataFrame, str))
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        return whole(*args, **more)

    monkeypatch.setattr(where, name, noting)
    return plans


def test_a_merge_moves_no_texts_before_it_writes(spark, tmp_path, monkeypatch):
    """Copies in a delivery are told apart by keys and digests, and only replaced rows are taken out."""
    first = [(s, d, f"l{d}", "m", "x") for s in "ABC" for d in (1, 2, 3)]
    second = [("A", 1, "l1", "m", "x"), ("A", 4, "l4", "m", "w"), ("A", 4, "l4", "m", "x"),
              ("A", 5, "l5", "m", "z"), ("A", 5, "l5", "m", "z"), ("B", 1, "l3", "a", "better"),
              ("B", 2, "l3", "a", "not so good")]
    dimension, prices = px.symbol_dimension(spark, {"i": "ABC"}), prices_of(spark, "ABC")
    once = NewsEngine(dimension, prices, delivery(spark, first + second), duplicates="drop")
    once.save(str(tmp_path / "once"))
    root = str(tmp_path / "turns")
    NewsEngine(dimension, prices, delivery(spark, first)).save(root)
    written = plans_of(monkeypatch, refresh, "written")
    replaced = plans_of(monkeypatch, versions.Draft, "replace_parts")
    assert refresh.merge_articles(spark, root, delivery(spark, second))[1] == ["symbol_A", "symbol_B"]
    assert "Exchange" not in written["delivery"]
    assert "text:string" not in written["changes"] and "text" not in written["replaced"]
    # the one shuffle of whole rows is that of the writer
    assert "Exchange" not in replaced["articles"].replace("BroadcastExchange", "")
    a, b = (snapshots.load_all(spark, str(tmp_path / name)) for name in ("once", "turns"))
    for name in ("articles", "links", "days", "corpus"):
        assert rows(getattr(a, name).drop("sources", "top")) == rows(
            getattr(b, name).drop("sources", "top")), name


def test_a_save_does_not_move_texts_to_its_symbols(spark, tmp_path, monkeypatch):
    """Symbols that are computed from a large table are few, which Spark sees once they are stored."""
    root, large = str(tmp_path), spark.range(200_000)
    engines = []
    for names in ("ABC", "AB"):
        symbols = large.selectExpr(f"substring('{names}', 1 + CAST(id % {len(names)} AS INT), 1) AS symbol",
                                   "'i' AS industry").distinct()
        engines.append(NewsEngine(symbols, prices_of(spark, "ABC"), articles_of(
            spark, "ABC", text=names), duplicates="keep"))
    plans = plans_of(monkeypatch, versions.Draft, "write")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        for engine in engines:
            engine.save(root)
            assert "SortMergeJoin" not in plans["articles"] and "Join" not in plans["corpus"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    load = snapshots.load_all(spark, root)
    assert {(r.symbol, r.text) for r in load.articles.collect()} == {("A", "AB"), ("B", "AB"), ("C", "ABC")}
    assert {(r.symbol, r.n_articles) for r in load.corpus.collect()} == {(s, 5) for s in "ABC"}
    assert load.links.count() == 15 and load.days.count() == 18
