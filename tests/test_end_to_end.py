"""From files to reports, as the README shows."""

import datetime as dt
import json

import pytest
from pyspark.errors.exceptions.captured import SparkRuntimeException

from newstide import NewsEngine, schemas
from newstide.functions.sentiment import with_sentiment
from newstide.sources import news, prices as px

GOOD = "the day was good for the company and the market."
BAD = "a loss of a lot in a day to regret."
LEXICON = {"the": 1, "and": 1, "for": 1, "of": -1, "to": -1, "in": -1, "a": -1}
NEUTRAL = "shares closed with little change today."


def response(day, texts):
    return {"articles": [
        {"id": f"{day}.{i}", "title": text, "link": f"http://n.example.com/{day}/{i}",
         "published": f"{day} 07:30:00", "source": {"href": "http://n.example.com"}, "text": text}
        for i, text in enumerate(texts)] + [{"id": "x", "published": "not a time"}]}


def test_files_to_reports(spark, tmp_path):
    start = dt.date(2015, 1, 5)
    days = [start + dt.timedelta(n) for n in range(12) if (start + dt.timedelta(n)).weekday() < 5]
    lines = ["symbol,date,open,high,low,close,volume"]
    for i, day in enumerate(days):
        # BP rises by 1 %, XOM falls by 1 %; one row is incomplete
        lines.append(f"BP,{day},100,102,99,101,{'' if i == 3 else 10}")
        lines.append(f"XOM,{day},100,102,98,99,10")
    (tmp_path / "prices.csv").write_text("\n".join(lines))
    # a mean score of 0 would give no prediction, so the bad news comes with a neutral article
    for symbol, texts in (("BP", [GOOD, GOOD]), ("XOM", [BAD, NEUTRAL])):
        for copy in (0, 1):
            at = tmp_path / "responses" / f"symbol={symbol}" / f"bucket_start=2015-01-0{5 + copy}"
            at.mkdir(parents=True)
            (at / "r.json").write_text(json.dumps(response(days[0], texts)))

    symbols = px.symbol_dimension(spark, {"oil": ["BP", "XOM"], "airline": ["DAL"]})
    prices = px.read_prices(spark, str(tmp_path / "prices.csv"), "csv", start=start, symbols=symbols)
    found = news.flatten_articles(
        news.read_search_results(spark, str(tmp_path / "responses"), multi_line=True))
    articles = with_sentiment(news.project_articles(news.valid_publications(found)),
                              lexicon=LEXICON)
    assert articles.schema == schemas.ARTICLES
    # both buckets hold the same articles, which is an error unless something is done about it
    with pytest.raises(SparkRuntimeException, match="duplicate key"):
        NewsEngine(symbols, prices, articles).corpus_stats().collect()
    engine = NewsEngine(symbols, prices, articles, duplicates="drop")

    timeline = {(r.symbol, r.date): r for r in engine.timeline().collect()}
    assert len(timeline) == 2 * len(days) - 1
    assert ("BP", days[3]) not in timeline
    assert (timeline["BP", days[0]].n_links, timeline["BP", days[1]].n_links) == (2, 0)
    assert sorted((r.symbol, r.position) for r in engine.links().collect()) == [
        ("BP", 1), ("BP", 2), ("XOM", 1), ("XOM", 2)]
    assert (timeline["BP", days[0]].change, timeline["XOM", days[0]].change) == (1.0, -1.0)

    # w = 3 sees the news for seven days from its own, and three more by the fill
    accuracy = {r.symbol: r for r in engine.analyze_accuracy(window=3).collect()}
    assert accuracy["BP"].text_pos_accuracy == accuracy["XOM"].text_neg_accuracy == 1.0
    assert accuracy["BP"].text_hold_accuracy == 0.0
    industries = {r.industry: r for r in engine.analyze_accuracies([3, 7]).collect()}
    assert set(industries) == {"oil"}
    assert tuple(engine.corpus_stats().first()) == (4, 0, 1)
    engine.save_sample(str(tmp_path / "sample"), n=1)
    assert spark.read.csv(str(tmp_path / "sample"), header=True).count() == 2
