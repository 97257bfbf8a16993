"""Edge cases of the scalar rules, with hand-computed expectations."""

import time

import pytest
from pyspark.errors.exceptions.captured import PythonException
from pyspark.sql import functions as F

from newstide.catalog.adapters import LEXICON
from newstide.functions import literal, markup, sentiment as s, signals as g
from newstide.sources.pages import extract_pages, page_failures

NAN = float("nan")


def values(spark, schema, rows, *expressions):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).selectExpr(*expressions).collect()]


@pytest.mark.parametrize("score, expected", [
    (None, ""), (NAN, ""), (0.0, ""), (44.9, "sell"), (45.0, ""), (50.0, "hold"), (55.0, ""),
    (55.1, "buy"), (100.0, "buy"), (0.1, "sell")])
def test_classify(spark, score, expected):
    assert values(spark, "x DOUBLE", [(score,)], g.classify("x")) == [(expected,)]


@pytest.mark.parametrize("prediction, change, expected", [
    ("", 1.0, -1), (None, 1.0, -1),
    ("hold", -0.25, 0), ("hold", -0.2, 1), ("hold", 0.0, 1), ("hold", 0.25, 0), ("hold", 0.3, 0),
    ("buy", 0.25, 0), ("buy", 0.3, 1), ("buy", -0.3, 0),
    ("sell", -0.25, 0), ("sell", -0.3, 1), ("sell", 0.3, 0),
    ("hold", None, 0), ("buy", None, 0), ("sell", None, 0),
    ("hold", NAN, 0), ("buy", NAN, 0), ("sell", NAN, 0)])
def test_grade(spark, prediction, change, expected):
    got = values(spark, "p STRING, c DOUBLE", [(prediction, change)], g.grade("p", "c"))
    assert got == [(expected,)]


def test_day_change(spark):
    rows = [(100.0, 101.0), (0.0, 5.0), (None, 5.0), (8.0, 6.0)]
    got = values(spark, "o DOUBLE, c DOUBLE", rows, g.day_change("o", "c"))
    assert got == [(1.0,), (None,), (None,), (-25.0,)]


def test_small_helpers(spark):
    row = [("2024-02-03", None, 3, 0, "x" * 200, "x" * 201)]
    got = values(spark, "d STRING, n STRING, a INT, z INT, short STRING, long STRING", row,
                 g.format_day("to_date(d)"), g.format_day("to_date(n)"), g.safe_ratio("a", "z"),
                 g.safe_ratio("a", "a"), g.has_text("short"), g.has_text("long"), g.has_text("n"),
                 g.or_empty("n"), g.has_prediction("n"), g.has_prediction("''"),
                 g.bucket_of("to_date(d)", "DATE '2024-01-06'"),
                 g.bucket_of("to_date(d)", "DATE '2024-01-07'"))
    assert got == [("2024-02-03", "", 0.0, 1.0, False, True, False, "", False, False, 1, 0)]


@pytest.mark.parametrize("url, host", [
    ("http://a.example.com/x?y=1", "a.example.com"), ("https://b.example.org", "b.example.org"),
    ("https://c.example.net:8080/", "c.example.net"), ("no url", None), (None, None)])
def test_source_host(spark, url, host):
    assert values(spark, "u STRING", [(url,)], g.source_host("u")) == [(host,)]


@pytest.mark.parametrize("window, lags", [
    (0, [0, 0, 0, 0, 1, 2, 3]), (1, [0, 0, 0, 1, 2, 3, 4]), (2, [0, 0, 1, 2, 3, 4, 5]),
    (3, [0, 1, 2, 3, 4, 5, 6]), (7, [4, 5, 6, 7, 8, 9, 10])])
def test_band_lags(window, lags):
    assert g.band_lags(window) == lags


def test_negative_window():
    with pytest.raises(ValueError):
        g.band_lags(-1)


FIVE, SIX = "one two three four five", "the two three four five six"


@pytest.mark.parametrize("text, expected", [
    (None, None), ("", None), (FIVE, None), (SIX, 100), (FIVE + ". " + SIX + "!", 100),
    ("of two three four five six", 0), ("one two three four five six", 50),
    ("of two three four five six\nTHE two three four five six", 50),
    # classes 2, 2, 0: 50 * 4 / 3 = 66.67 is cut to 66
    (SIX + "." + SIX + "?" + "of two three four five six", 66),
    # digits and accents end tokens
    ("a1b c d e f", 0), ("thé b c d", None)])
def test_lexicon_sentiment(spark, text, expected):
    got = values(spark, "t STRING", [(text,)], s.lexicon_sentiment("t", LEXICON))
    assert got == [(expected,)]


def test_lexicon_and_length_are_parameters(spark):
    got = values(spark, "t STRING", [("it's good",)],
                 s.lexicon_sentiment("t", {"good": 3, "s": -1}, min_tokens=3),
                 s.lexicon_sentiment("t", {}, min_tokens=1))
    assert got == [(100, 50)]


def test_many_words_of_a_lexicon(spark):
    lexicon = {f"w{chr(97 + i // 26)}{chr(97 + i % 26)}": 1 - 2 * (i % 2) for i in range(400)}
    got = values(spark, "t STRING", [("waa wac wae wab x y",)], s.lexicon_sentiment("t", lexicon))
    assert got == [(100,)]


def test_with_sentiment_of_missing_channels(spark):
    df = spark.createDataFrame([(SIX,)], "title STRING")
    assert s.with_sentiment(df, lexicon=LEXICON).collect()[0].asDict() == {
        "title": SIX, "title_sentiment": 100, "text_sentiment": None}
    with pytest.raises(ValueError):
        s.with_sentiment(df)


def test_model_hook_is_called_with_full_chunks(spark, tmp_path):
    """Sentences of all documents and both channels fill the calls; the model is loaded once."""
    log = str(tmp_path / "calls")

    def load():
        def model(sentences):
            with open(log, "a") as file:
                file.write(f"{len(sentences)}\n")
            return [2 if "GOOD" in x else 0 for x in sentences]
        return model

    classifier = s.sentence_classifier(load, sentences_per_call=4)
    good, bad = "GOOD b c d e f", "b c d e f g"
    rows = [(None, good), ("", ".".join([good, good, bad, "too short", bad, good])), (bad, "x"),
            (good, None)]
    df = s.with_sentiment(spark.createDataFrame(rows, "title STRING, text STRING").coalesce(1),
                          classifier=classifier)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.title_sentiment, r.text_sentiment) for r in df.collect()] == [
        (None, 100), (None, 60), (0, None), (100, None)]
    assert df.columns == ["title", "text", "title_sentiment", "text_sentiment"]
    with open(log) as file:
        assert file.read().split() == ["4", "4"]


def test_model_hook_refuses_another_number_of_classes(spark):
    classifier = s.sentence_classifier(lambda: lambda sentences: [1])
    df = spark.createDataFrame([("a b c d e f. a b c d e f",)], "text STRING")
    with pytest.raises(PythonException, match="1 classes for 2 sentences"):
        s.with_sentiment(df, classifier=classifier).collect()


@pytest.mark.parametrize("written, expected", [
    ("2015-01-02 08:00:00", "2015-01-02 08:00"), ("2015-01-02", "2015-01-02 00:00"),
    ("2015-1-2", "2015-01-02 00:00"), ("2015-01-02T08:00:00Z", "2015-01-02 08:00"),
    ("2015-01-02T08:00:00+02:00", "2015-01-02 06:00"), ("2015-01-02 23:30:00-0100", None),
    ("2015-01-02 08:00:00 GMT", "2015-01-02 08:00"), ("2015-01-02T08:00:00.25-05:30", "2015-01-02 13:30"),
    ("Fri, 02 Jan 2015 08:00:00 GMT", "2015-01-02 08:00"), ("2 Jan 2015 08:00:00 +0130", "2015-01-02 06:30"),
    ("Fri, 2 Jan 2015 23:30:00 -0100", "2015-01-03 00:30"), ("Friday, 02 Jan 2015 08:00 UTC", "2015-01-02 08:00"),
    ("Fri, 02 Jan 2015 08:00:00 EST", "2015-01-02 13:00"), ("2015", None), ("2015-01", None),
    ("Sat sometime", None), ("Fri, 32 Jan 2015 08:00:00 GMT", None), ("", None), (None, None)])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_publication_times(spark, written, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = values(spark, "t STRING", [(written,)], g.to_published("t"))[0][0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if written == "2015-01-02 23:30:00-0100":  # an offset without a colon is ISO basic style
        assert got is None or f"{got:%Y-%m-%d %H:%M}" == "2015-01-03 00:30"
    else:
        assert (None if got is None else f"{got:%Y-%m-%d %H:%M}") == expected


@pytest.mark.parametrize("url, host", [
    ("https://user:pw@Host.com/x", "host.com"), ("http://EXAMPLE.com:80?q", "example.com"),
    ("http://a@b@c.org#f", "c.org"), ("ftp://h", "h"), ("no scheme", None), ("http:///x", None), (None, None)])
def test_source_host(spark, url, host):
    assert values(spark, "u STRING", [(url,)], g.source_host("u")) == [(host,)]


def test_literal(spark):
    for value in ["it's", "back\\slash", r"[^a-z.!?\n]+", "new\nline", '"quoted"']:
        assert spark.range(1).select(F.expr(literal(value))).first()[0] == value


PAGE = """<html><head><title>Up &amp; down</title><style>p{}</style></head><body>
<nav><article>not this</article></nav><!-- <article>nor this</article> -->
<script>var a = "<article>no</article>";</script>
<article class="x"><h1>Head</h1><p>One <b>bold</b>&nbsp;word &lt;tag&gt; &amp;lt;</p>
<div class="ad">buy</div><pre>kept</pre><br/>last   line</article></body></html>"""


def test_extract_pages(spark):
    rows = [(1, "https://a.example.com/1", PAGE), (2, "https://a.example.com/2", "<article>cut"),
            (3, "bad", None), (4, "http://b.example.com", "<title>t</title><article> </article>")]
    got = extract_pages(spark.createDataFrame(rows, "page_id INT, url STRING, html STRING"))
    assert got.columns == ["page_id", "url", "href", "title", "text"]
    assert [(r.href, r.title, r.text) for r in got.orderBy("page_id").collect()] == [
        ("a.example.com", "Up & down", "Head\nOne bold\u00a0word <tag> &lt;\nkept\nlast line"),
        ("a.example.com", None, "cut"), (None, None, None), ("b.example.com", "t", None)]


@pytest.mark.parametrize("html, text", [
    ("<article>a<div class='ad'>x<div>y</div>z</div>b</article>", "a b"),
    ("<article>one<article>two</article>three</article><article>next</article>", "onetwothree"),
    ("<article>&eacute; &#8217; &mdash; &#x1F389; &amp;lt; &unknown;</article>", "é ’ — 🎉 &lt; &unknown;"),
    ("<body><p>no article</p><nav>menu</nav></body>", "no article"),
    ("<body>around<main>inner</main></body>", "inner"),
    ("<body>text<article></article></body>", "text"),
    ("<article>a<img class='ad' src='x'>b<br>c<hr/>d</article>", "ab\ncd"),
    ("<article>a</p></div>b", "a\n\nb".replace("\n\n", "\n")),
    ("<article><script>if (a < b) '</article>'</script>kept</article>", "kept"),
    ("no markup at all", None), ("", None)])
def test_page_text(html, text):
    assert markup.read_page(html)[1] == text


@pytest.mark.parametrize("html, title, text", [
    ("<body><p class=ad>buy<p>two</p><p>three</p></body>", None, "two\nthree"),
    ("<html><title>T<body><p>all text", "T", "all text"),
    ("<title>t</title><p>hello</p>", "t", "hello"),
    ("<title>T<p>all text", "T", "all text"), ("<title>T<style>p{}</style><p>x", "T", "x"),
    ("<title>Use of <p> tags</title><p>x", "Use of <p> tags", "x"),
    ("<p>a</p><![x[abc", None, "a"), ("<p>a</p><a href='x>b", None, "a"), ("<p>x <", None, "x <"),
    ("<p>a<!-- c --!>b<!-->c<!-- d", None, "abc"), ("<p title=it's>t</p>", None, "t"),
    ("<ul><li>a<li class=ad>b<li>c</ul>d", None, "a\nc\nd"),
    ("<ul><li class=ad>b<ul><li>in</ul><p>still</p><li>c</ul>", None, "c"),
    ("<table><tr><td class=ad>x<td>y<tr><td>z</table>w", None, "y\nz\nw"),
    ("<table><tr><td class=ad>x<table><tr><td>in</table>still<td>y</table>", None, "y"),
    ("<dl><dt class=ad>x<dd>y</dl>", None, "y"), ("<h1 class=ad>x<h2>y</h2>", None, "y"),
    ("<div class=ad>x<span></div>y", None, "y"), ("<nav><ul><li>x</ul></nav>y", None, "y"),
    ("<p><span class=ad>x</span>y</p>", None, "y"), ("<p>1<b class=ad>x</p>y", None, "1\ny"),
    ("<svg><title>no</title><path/><p>yes</p>", None, "yes"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>out", None, "out"),
    ("<div><article>one</div>two", None, "one"), ("<article>a</article>b<article>c", None, "a"),
    ("<p>a</body></html>b", None, "a b".replace(" ", "")), ("<textarea><p>x</textarea>y", None, "<p>xy"),
    ("<p>1<script>no end", None, "1")])
def test_implied_tags_and_recovery(html, title, text):
    assert markup.read_page(html) == (title, text)


@pytest.mark.parametrize("repeated, end", [
    ("<a ", ""), ("<a ", ">"), ("<a b=", ""), ("<p class='", ""), ("<!--", ""), ("<![x[", ""),
    ("</", ""), ("<", ""), ("&am", ""), ("<title>", ""), ("<title><body>", "</title>"),
    ("<script>", ""), ("<li>", ""), ("<div><b>", "</p>" * 40_000), ("<b><p>", "</b>" * 40_000),
    ("<td><svg>", "<p>" * 40_000)])
def test_time_grows_with_the_page(repeated, end):
    """Four times the page takes four times as long, with room for a busy machine."""

    def seconds(n):
        page = "<body>" + repeated * n + end
        start = time.process_time()
        markup.read_page(page)
        return time.process_time() - start

    small = min(seconds(20_000) for _ in range(3))
    assert seconds(80_000) < 12 * small + 0.2


def test_a_page_that_fails_keeps_its_other_fields(spark):
    rows = [(1, "https://a.example.com/1", "<title>t</title><p>x"), (2, "https://a.example.com/2", "%PDF\0<p>"),
            (3, "https://b.example.com/", None)]
    pages = spark.createDataFrame(rows, "page_id INT, url STRING, html STRING")
    found = extract_pages(pages, errors=True).orderBy("page_id").collect()
    assert [(r.href, r.title, r.text) for r in found] == [
        ("a.example.com", "t", "x"), ("a.example.com", None, None), ("b.example.com", None, None)]
    assert [r.page_error is None for r in found] == [True, False, True]
    assert {tuple(r) for r in page_failures(pages).collect()} == {
        ("a.example.com", 2, 1), ("b.example.com", 1, 0)}
