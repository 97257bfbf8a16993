"""Readers, writers and the fetch plan."""

import datetime as dt
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from newstide import NewsEngine, schemas
from newstide.operators.corpus import corpus_stats, top_sources
from newstide.sources import news, prices as px, snapshots
from newstide.sources.layout import new_table_path, remove_table, scratch, shared_dir, written

D = dt.date


@pytest.fixture(scope="module")
def prices(spark):
    rows = [(s, D(2024, 1, d), 1.0 * d, 2.0 * d, 0.5 * d, 1.5 * d, d)
            for s in ("QCOM", "QCOM.A", "7") for d in (1, 2, 3, 4)]
    return spark.createDataFrame(rows, schemas.PRICES)


def keys(df):
    return sorted((r.symbol, r.date.day) for r in df.select("symbol", "date").collect())


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_price_scan(spark, prices, fmt, tmp_path):
    path = str(tmp_path / fmt)
    broken = spark.createDataFrame(
        [("QCOM", D(2024, 1, 2), float("nan"), 1.0, 1.0, 1.0, 1),
         ("QCOM", D(2024, 1, 3), 1.0, 1.0, 1.0, 1.0, None)], schemas.PRICES)
    prices.union(broken).write.option("header", True).format(fmt).save(path)
    watched = px.symbol_dimension(spark, {"chips": ["QCOM", "NVDA"], "other": ["7"]})
    got = px.read_prices(spark, path, fmt, start="2024-01-02", end=D(2024, 1, 3), symbols=watched)
    assert keys(got) == [("7", 2), ("7", 3), ("QCOM", 2), ("QCOM", 3)]
    assert got.schema.names == schemas.PRICES.names
    assert len(px.read_prices(spark, path, fmt).collect()) == 12


def test_unpivot_wide_prices(spark):
    wide = spark.createDataFrame(
        [("2024-01-02", 1.0, 2.0, 10, 5.0, None), ("2024-01-03", 3.0, 4.0, 20, 6.0, 7.0)],
        "`Date` STRING, `A|Open` DOUBLE, `A|Close` DOUBLE, `A|Volume` BIGINT, "
        "`B.X|Open` DOUBLE, `B.X|Close` DOUBLE")
    got = px.unpivot_prices(wide)
    assert got.schema.names == schemas.PRICES.names
    assert sorted((r.symbol, r.date.day, r.open, r.close, r.volume) for r in got.collect()) == [
        ("A", 2, 1.0, 2.0, 10), ("A", 3, 3.0, 4.0, 20), ("B.X", 2, 5.0, None, None),
        ("B.X", 3, 6.0, 7.0, None)]


def test_symbol_dimension(spark):
    industries = {"oil": ["BP", "XOM"], "air": ["DAL"], "none": []}
    flat = {tuple(r) for r in px.symbol_dimension(spark, industries).collect()}
    mapped = spark.createDataFrame([(industries,)], "industries MAP<STRING, ARRAY<STRING>>")
    assert flat == {tuple(r) for r in px.flatten_symbol_map(mapped).collect()}
    assert flat == {("oil", "BP"), ("oil", "XOM"), ("air", "DAL")}


RESPONSE = {"feed": {"ignored": 1}, "articles": [
    {"id": "1", "title": "t", "link": "l1", "published": "2015-01-03 08:00:00",
     "source": {"href": "h", "title": "H"}, "extra": [1]},
    {"id": "2", "title": "u", "link": "l2", "published": "Sat sometime"},
    {"id": "3", "link": "l3", "text": "body", "published": "2015-01-02T23:59:59Z"},
    {"id": "4", "link": "l4", "published": None}]}


def test_search_scan_of_one_file_per_response(spark, tmp_path):
    for symbol, start in (("QCOM", "2015-01-01"), ("7", "2015-01-29")):
        at = tmp_path / f"symbol={symbol}" / f"bucket_start={start}"
        at.mkdir(parents=True)
        (at / "response.json").write_text(json.dumps(RESPONSE, indent=1))
    (tmp_path / "symbol=7" / "bucket_start=2015-02-26").mkdir()
    (tmp_path / "symbol=7" / "bucket_start=2015-02-26" / "r.json").write_text("{}")
    found = news.read_search_results(spark, str(tmp_path), multi_line=True)
    assert found.schema["symbol"].dataType.typeName() == "string"
    flat = news.flatten_articles(found)
    assert flat.count() == 8
    valid = news.valid_publications(flat)
    assert sorted((r.symbol, r.link, r.date) for r in valid.collect()) == sorted(
        (s, link, day) for s in ("QCOM", "7")
        for link, day in (("l1", D(2015, 1, 3)), ("l3", D(2015, 1, 2))))
    projected = news.project_articles(valid.drop("id"))
    assert projected.schema == schemas.ARTICLES
    assert {(r.link, r.id, r.text, r.text_sentiment, r.source and r.source.href)
            for r in projected.collect()} == {("l1", None, None, None, "h"),
                                              ("l3", None, "body", None, None)}
    counts = {(r.symbol, str(r.bucket_start)): (r.n_articles, r.n_responses)
              for r in news.bucket_counts(found).collect()}
    assert counts == {("QCOM", "2015-01-01"): (4, 1), ("7", "2015-01-29"): (4, 1),
                      ("7", "2015-02-26"): (0, 1)}
    assert {tuple(r) for r in news.history_sizes(found).collect()} == {("QCOM", 1), ("7", 2)}


FAULTY = """{"symbol":"a","articles":[{"id":"1","link":"l"}]}
{"symbol":"a","articles":[{"id":"1","li
{"symbol":"a","articles":"oops"}
{"symbol":"a","articles":[{"id":"1"},"x"]}
{"symbol":"a","bucket_end":"zzz","articles":[]}
{"symbol":"a","bucket_end":"2023-12-31","articles":[]}
{"symbol":"a","message":"quota"}
{"articles":[]}
"text"
[{"symbol":"q","articles":[]},{"symbol":"r","articles":[]}]
garbage
"""


def test_rejected_responses_are_kept_with_file_and_reason(spark, tmp_path):
    folder = tmp_path / "bucket_start=2024-01-01"
    folder.mkdir()
    (folder / "a.json").write_text(FAULTY)
    (folder / "b.json").write_text('{"symbol":"b","articles":[]}\n')
    scan = news.scan_responses(spark, str(tmp_path))
    reasons = {"not JSON": 2, "wrong type": 4, "bucket ends before it starts": 1,
               "no article list": 1, "no symbol": 1}
    assert scan.count() == 13
    bad = news.rejected(scan)
    # the same verdicts, whatever columns a query asks for
    assert news.accepted(scan).count() == news.accepted(scan).select("symbol").collect().__len__() == 4
    assert bad.count() == bad.select("file").count() == 9
    assert {r.reason: r.n for r in bad.groupBy("reason").agg(F.count("*").alias("n")).collect()} == reasons
    assert {r.file.rsplit("/", 1)[1] for r in bad.collect()} == {"a.json"}
    assert sorted(r.record for r in bad.where("reason = 'not JSON'").collect()) == [
        "garbage", '{"symbol":"a","articles":[{"id":"1","li']
    assert sorted(r.n_responses for r in news.rejects_per_file(scan).collect()) == [1, 1, 1, 1, 2, 3, 4]
    assert sorted(r.symbol for r in news.read_search_results(spark, str(tmp_path)).collect()) == [
        "a", "a", "b", "q", "r"]
    with pytest.raises(Exception, match="response rejected"):
        news.read_search_results(spark, str(tmp_path), rejects="error").collect()
    with pytest.raises(ValueError):
        news.read_search_results(spark, str(tmp_path), rejects="maybe")


def test_a_file_cut_short_is_one_reject(spark, tmp_path):
    (tmp_path / "symbol=A").mkdir()
    whole = json.dumps(RESPONSE, indent=1)
    for name, text in (("good", whole), ("short", whole[:len(whole) // 2]), ("empty", "")):
        (tmp_path / "symbol=A" / f"{name}.json").write_text(text)
    scan = news.scan_responses(spark, str(tmp_path), multi_line=True)
    assert [(r.symbol, r.reason, r.file.rsplit("/", 1)[1]) for r in news.rejected(scan).collect()] == [
        ("A", "not JSON", "short.json")]
    assert news.accepted(scan).count() == 1


def test_decoded_bodies_have_a_reason(spark):
    bodies = [(line,) for line in FAULTY.splitlines()[:4]] + [("{}",), (None,), ("",)]
    found = news.decode_responses(spark.createDataFrame(bodies, "body STRING"))
    assert [(r.reason, r.articles is None) for r in found.collect()] == [
        (None, False), ("not JSON", True), ("wrong type", True), ("wrong type", True),
        ("no article list", True), ("not JSON", True), ("not JSON", True)]


def test_parse_response(spark):
    bodies = spark.createDataFrame([(json.dumps(RESPONSE),), ("no json",), (None,)], "body STRING")
    got = bodies.selectExpr(f"{news.parse_response('body')} AS a").collect()
    assert [None if r.a is None else len(r.a) for r in got] == [4, None, None]
    assert got[0].a[0].source.href == "h" and got[0].a[1].source is None


def test_concat_articles(spark):
    a = spark.createDataFrame([("x", 1)], "link STRING, n INT")
    b = spark.createDataFrame([("y", "t")], "link STRING, title STRING")
    assert {tuple(r) for r in news.concat_articles(a, b).collect()} == {
        ("x", 1, None), ("y", None, "t")}


@pytest.mark.parametrize("days, starts", [
    (0, []), (1, [0]), (27, [0]), (28, [0]), (29, [0, 28]), (56, [0, 28]), (57, [0, 28, 56])])
def test_fetch_buckets(spark, days, starts):
    first = D(2015, 1, 1)
    ranges = spark.createDataFrame([("a", first, first + dt.timedelta(days))],
                                   "symbol STRING, start_date DATE, end_date DATE")
    got = news.fetch_buckets(ranges).orderBy("bucket_start").collect()
    assert [(r.bucket_start - first).days for r in got] == starts
    assert all((r.bucket_end - r.bucket_start).days == 28 for r in got)


def test_fetch_requests(spark, prices):
    instruments = spark.createDataFrame(
        [("QCOM", "t", "Qualcomm", {}), ("EMPTY", "t", "no prices", {})], schemas.INSTRUMENTS)
    got = news.fetch_requests(instruments, prices, interval_days=2).orderBy("from").collect()
    assert [tuple(r) for r in got] == [
        ("QCOM", "Qualcomm", "2024-01-01", "2024-01-03", "US", "en"),
        ("QCOM", "Qualcomm", "2024-01-03", "2024-01-05", "US", "en")]


@pytest.mark.parametrize("layout", ["symbol", "bucket"])
def test_snapshot_round_trip(spark, prices, layout, tmp_path):
    root = str(tmp_path)
    snapshots.write_snapshot(prices, root, "prices", layout)
    back = snapshots.read_snapshot(spark, root, "prices")
    assert sorted(map(tuple, back.select(*prices.columns).collect())) == sorted(
        map(tuple, prices.collect()))
    # names that share a prefix or look like numbers do not collide
    for symbol in ("QCOM", "QCOM.A", "7"):
        one = snapshots.read_snapshot(spark, root, "prices", symbol)
        assert keys(one) == [(symbol, d) for d in (1, 2, 3, 4)]
        assert len(one.inputFiles()) >= 1
        assert "PartitionFilters: [part" in one._jdf.queryExecution().executedPlan().toString()
    assert snapshots.read_snapshot(spark, root, "prices", "none").count() == 0
    assert snapshots.read_snapshot(spark, root, "absent") is None


def test_snapshot_replaces_only_the_written_symbols(spark, prices, tmp_path):
    root = str(tmp_path)
    snapshots.write_snapshot(prices, root, "prices")
    snapshots.write_snapshot(prices.where("symbol = '7' AND day(date) = 1"), root, "prices")
    got = keys(snapshots.read_snapshot(spark, root, "prices"))
    assert got == [("7", 1)] + [(s, d) for s in ("QCOM", "QCOM.A") for d in (1, 2, 3, 4)]


@pytest.mark.parametrize("name", ["prices", "unknown"])
def test_layout_changes_never_double_rows(spark, prices, name, tmp_path):
    root = str(tmp_path)
    snapshots.write_snapshot(prices, root, name, "symbol")
    snapshots.write_snapshot(prices, root, name, "bucket")
    assert snapshots.read_snapshot(spark, root, name).count() == 12
    assert snapshots.read_snapshot(spark, root, name, "7").count() == 4
    # writing single symbols would leave the others behind in their buckets
    with pytest.raises(ValueError):
        snapshots.write_snapshot(prices.where("symbol = '7'"), root, name, "symbol")
    assert snapshots.read_snapshot(spark, root, name).count() == 12


def test_bucket_files_are_sorted(spark, tmp_path):
    rows = [(f"s{i % 300}", D(2024, 1, 1) + dt.timedelta(i % 17), 1.0, 1.0, 1.0, 1.0, i)
            for i in range(3000)]
    snapshots.write_snapshot(spark.createDataFrame(rows, schemas.PRICES).repartition(8),
                             str(tmp_path), "prices", "bucket")
    for path in (tmp_path / "prices").rglob("*.parquet"):
        found = [(r.symbol, r.date) for r in spark.read.parquet(str(path)).collect()]
        assert found == sorted(found)


def test_stored_schema_is_not_inferred(spark, tmp_path):
    """An older file without a column and with another one reads as the table's schema."""
    old = spark.createDataFrame([("a", D(2024, 1, 1), 1.0, "x")],
                                "symbol STRING, date DATE, open DOUBLE, other STRING")
    snapshots.write_snapshot(old, str(tmp_path), "prices")
    got = snapshots.read_snapshot(spark, str(tmp_path), "prices")
    assert got.columns == schemas.PRICES.names
    assert tuple(got.first()) == ("a", D(2024, 1, 1), 1.0, None, None, None, None)


def test_instruments_and_responses_are_saved(spark, prices, tmp_path):
    symbols = px.symbol_dimension(spark, {"i": ["QCOM", "7"]})
    instruments = spark.createDataFrame([("QCOM", "t", "Qualcomm", {"k": "v"})], schemas.INSTRUMENTS)
    article = ("1", "t", "l1", "2015-01-03", ("h", "H"), "x")
    responses = spark.createDataFrame([("QCOM", D(2015, 1, 1), D(2015, 1, 29), [article])],
                                      schemas.SEARCH_RESULTS)
    engine = NewsEngine(symbols, prices, spark.createDataFrame([], schemas.ARTICLES),
                        instruments=instruments, search_results=responses)
    engine.save(str(tmp_path))
    again = NewsEngine.load(spark, str(tmp_path), symbols)
    assert again.instruments.collect() == instruments.collect()
    assert again.search_results.collect() == responses.collect()
    sizes = news.with_history_size(again.instruments, again.search_results).collect()
    assert [(r.symbol, r.n_groups) for r in sizes] == [("QCOM", 1)]


def test_wide_price_files(spark, tmp_path):
    (tmp_path / "wide.csv").write_text(
        "Date,A|Open,A|High,A|Low,A|Close,A|Volume,B|Open\n"
        "2024-01-02,1,2,0.5,1.5,10,\n2024-01-03,3,4,2.5,3.5,20,9\n")
    got = px.read_prices(spark, str(tmp_path / "wide.csv"), "csv", start="2024-01-03", wide=True)
    assert [tuple(r) for r in got.collect()] == [("A", D(2024, 1, 3), 3.0, 4.0, 2.5, 3.5, 20)]


def test_full_load_and_engine_save(spark, prices, tmp_path):
    articles = spark.createDataFrame(
        [("QCOM", dt.datetime(2024, 1, 2), D(2024, 1, 2), "t", f"l{i}", (f"h{i % 2}", "H"), str(i),
          "x" * (199 + i), 50, 60) for i in range(5)], schemas.ARTICLES)
    symbols = px.symbol_dimension(spark, {"i": ["QCOM", "7"]})
    engine = NewsEngine(symbols, prices, articles)
    engine.save(str(tmp_path))
    load = snapshots.load_all(spark, str(tmp_path))
    assert load.instruments is None and load.search_results is None
    assert load.prices.count() == 8 and load.articles.count() == 5
    assert {r.date.day: r.n_links for r in load.timeline.where("symbol = 'QCOM'").collect()} == {
        1: 0, 2: 5, 3: 0, 4: 0}
    assert [r.link for r in load.links.orderBy("position").collect()] == [f"l{i}" for i in range(5)]
    assert {(r.href, r.n, r.weight) for r in load.source_weights.collect()} == {
        ("h0", 3, 1.6), ("h1", 2, 1.4)}
    again = NewsEngine.load(spark, str(tmp_path), symbols)
    assert sorted(map(tuple, again.analyze_accuracies([3]).collect())) == sorted(
        map(tuple, engine.analyze_accuracies([3]).collect()))
    with pytest.raises(FileNotFoundError):
        NewsEngine.load(spark, str(tmp_path / "absent"), symbols)
    assert tuple(corpus_stats(articles).first()) == (5, 3, 2)
    assert [tuple(r) for r in top_sources(articles, 1).collect()] == [("h0", 3)]


def test_csv_sink_keeps_nested_values_and_awkward_text(spark, tmp_path):
    text = 'He said "no",\nthen; left\\'
    df = spark.createDataFrame([("a", ("http://h", "H, \"x\""), text)],
                               "symbol STRING, source STRUCT<href: STRING, title: STRING>, text STRING")
    snapshots.write_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"', multiLine=True).first()
    assert back.text == text
    assert json.loads(back.source) == {"href": "http://h", "title": 'H, "x"'}


def test_shared_dir_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert new_table_path(spark, "t").startswith(named)
    assert new_table_path(spark, "t") != new_table_path(spark, "t")


class Session:
    """A session without a shared folder."""

    class sparkContext:
        master = "local[8]"

        @staticmethod
        def getCheckpointDir():
            return None

    conf: dict[str, str] = {}


def test_without_a_shared_folder_there_is_none():
    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_folder_of_the_context_counts():
    class Given(Session):
        class sparkContext(Session.sparkContext):
            @staticmethod
            def getCheckpointDir():
                return "hdfs:/shared"

    assert shared_dir(Given()) == "hdfs:/shared"


def test_intermediate_tables_are_removed(spark):
    kept = written(spark.range(3).toDF("id"), "gone")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and kept.count() == 3
    remove_table(spark, path)
    assert not os.path.exists(path)


def test_tables_of_a_block_go_with_it(spark):
    def folder(df):
        return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]

    with scratch() as keep:
        first = written(spark.range(3).toDF("id"), "first")
        with scratch() as keep_inner:
            gone = folder(written(first, "inner"))
            second = keep_inner(written(first, "second"))
        assert not os.path.exists(gone) and second.count() == 3
        third = keep(written(second, "third"))
        away = folder(first), folder(second)
    assert third.count() == 3 and not any(map(os.path.exists, away))
    with pytest.raises(InterruptedError), scratch():
        gone = folder(written(third, "failed"))
        raise InterruptedError
    assert not os.path.exists(gone) and third.count() == 3


def test_queries_run_from_any_folder(tmp_path):
    """Workers get the package although neither the folder nor PYTHONPATH has it."""
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "print('rows', e.queries()['A8_page_text'](s, sys.argv[2]).count())\n"
            "print('text', e.queries()['A8_page_text'](s, sys.argv[2]).first().text[:1] != '')\n")
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, top, "/root/testdata/sf0.001"], cwd=tmp_path,
                          env=env, capture_output=True, text=True, timeout=300)
    assert "rows 50" in done.stdout and "text True" in done.stdout, done.stderr[-2000:]


def test_drop_incomplete_and_slice(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 1.0), (D(2024, 1, 2), float("nan")),
                                (D(2024, 1, 3), None), (D(2024, 1, 4), 2.0)], "date DATE, x DOUBLE")
    assert [r.x for r in px.drop_incomplete(df).orderBy("date").collect()] == [1.0, 2.0]
    assert px.date_slice(df, start="2024-01-02").count() == 3
    assert px.date_slice(df, end="2024-01-02").count() == 2
    assert px.date_slice(df).count() == 4
    empty = df.where("FALSE").select(F.lit("a").alias("symbol"), "date")
    assert px.date_ranges(empty).count() == 0


def test_requests_are_for_uncovered_days_only(spark):
    """Random buckets that overlap, touch and lie apart, against a set of days."""
    import random
    rng = random.Random(8)
    ranges = {s: (rng.randint(0, 9), rng.randint(25, 40)) for s in "abcdef"}
    buckets = [(s, start, start + rng.randint(0, 6)) for s in "abcd" for start in
               (rng.randint(-5, 45) for _ in range(rng.randint(1, 9)))]

    def date(n):
        return D(2024, 3, 1) + dt.timedelta(n)

    days = spark.createDataFrame([(s, date(a), date(b)) for s, (a, b) in ranges.items()],
                                 "symbol STRING, start_date DATE, end_date DATE")
    stored = spark.createDataFrame([(s, date(a), date(b), None) for s, a, b in buckets],
                                   schemas.SEARCH_RESULTS)
    gaps = news.uncovered_ranges(days, stored).collect()
    found = [(g.symbol, (g.start_date - date(0)).days + k) for g in gaps
             for k in range((g.end_date - g.start_date).days)]
    covered = {(s, d) for s, a, b in buckets for d in range(a, b)}
    wanted = {(s, d) for s, (a, b) in ranges.items() for d in range(a, b)} - covered
    assert len(found) == len(set(found)) and set(found) == wanted
    prices = spark.createDataFrame([(s, date(d), 1.0, 1.0, 1.0, 1.0, 1) for s, r in ranges.items()
                                    for d in r], schemas.PRICES)
    instruments = spark.createDataFrame([(s, "t", s.upper(), None) for s in ranges], schemas.INSTRUMENTS)
    asked = news.missing_requests(instruments, prices, stored, interval_days=4).collect()
    assert {r.q for r in asked} <= set("ABCDEF") and all(r["from"] < r["to"] for r in asked)
    spans = [(r.symbol, (D.fromisoformat(r["from"]) - date(0)).days + k) for r in asked for k in
             range((D.fromisoformat(r["to"]) - D.fromisoformat(r["from"])).days)]
    assert sorted(spans) == sorted(wanted)
    nothing = news.missing_requests(instruments, prices, stored.limit(0), 28)
    assert nothing.count() == sum(-(-(b - a) // 28) for a, b in ranges.values())
