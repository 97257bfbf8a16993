"""The timeline: one row per symbol and trading day with the day's news."""

from pyspark.sql import Column, DataFrame, functions as F

from newstide.functions.signals import day_change, nan_to_null
from newstide.functions.sentiment import CHANNELS
from newstide.operators.ordering import with_position

# What a day's articles come down to; see ``day_sums``.
COUNTERS = ("n_links", "n_resolved", *(f"{c}_{x}" for c in CHANNELS for x in ("sum", "n")))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, which raises when it is evaluated if a key occurs more than once.

    The check is part of the plan, so that nothing runs while a report is built. It moves the keys
    only.
    """
    n = duplicate_keys(df, *keys).agg(F.count("*")).scalar()
    message = f"duplicate key ({', '.join(keys)}) in so many cases: "
    return df.where(F.when(n == 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(message), n.cast("string")))))


def link_order(articles: DataFrame) -> list[str]:
    """What decides between copies of a link, as far as scores depend on it."""
    wanted = {"published": "published", "id": "id", "date": "date", "source": "source.href AS href",
              **{f"{c}_sentiment": f"{c}_sentiment" for c in CHANNELS}}
    return [column for name, column in wanted.items() if name in articles.columns]


def drop_duplicate_links(articles: DataFrame, digest: Column | None = None) -> DataFrame:
    """Keep one article per (symbol, link): the earliest, then the smallest id, date, source and
    sentiments, then the smallest SHA-256 of the row as JSON. Rows without a symbol or a link have
    no key and stay.

    Keys are counted first, merged map-side; whole rows are looked at only where a key collides, and
    their choice is merged map-side too, so a link with very many copies is no hot key. The other
    rows are moved as they are: slim rows that stand for whole ones carry the ``digest`` of these.
    """
    row = F.struct(*articles.columns)
    digest = F.sha2(F.to_json(row), 256) if digest is None else digest
    crowded = duplicate_keys(articles, "symbol", "link").select("symbol", "link")
    alone = articles.join(crowded, ["symbol", "link"], "left_anti").select(*articles.columns)
    copies = (articles.join(crowded, ["symbol", "link"], "left_semi").select(*articles.columns)
              .select("symbol", "link", row.alias("_row"), F.struct(
                  *map(F.expr, link_order(articles)),
                  digest.alias("digest")).alias("_order")))
    first = copies.groupBy("symbol", "link").agg(F.min("_order").alias("_first"))
    chosen = (copies.join(first, ["symbol", "link"])
              .where(F.col("_order").eqNullSafe(F.col("_first")))
              .groupBy("symbol", "link").agg(F.first("_row").alias("_row")))
    return alone.union(chosen.select("_row.*"))


def scored_survivors(articles: DataFrame) -> DataFrame:
    """What scores need of the articles that ``drop_duplicate_links`` keeps: symbol, link, date,
    source and sentiments. One aggregation of slim columns; texts are neither read nor moved."""
    # a row without a key is a group of its own
    keyed = F.col("symbol").isNotNull() & F.col("link").isNotNull()
    slim = articles.select("symbol", "link", F.struct(*map(F.expr, link_order(articles))).alias("_order"),
                           F.when(~keyed, F.monotonically_increasing_id()).alias("_row"))
    kept = slim.groupBy("symbol", "link", "_row").agg(F.min("_order").alias("_order"))
    return kept.select("symbol", "link", "_order.date", F.struct("_order.href").alias("source"),
                       *[f"_order.{c}_sentiment" for c in CHANNELS])


def unique_links(articles: DataFrame, duplicates: str = "error") -> DataFrame:
    """Articles under a policy for links that a symbol has more than once: 'error' raises when the
    result is evaluated, 'drop' keeps one of them, 'keep' lets each count."""
    policies = {"error": lambda: require_unique(articles, "symbol", "link"),
                "drop": lambda: drop_duplicate_links(articles), "keep": lambda: articles}
    if duplicates not in policies:
        raise ValueError(f"duplicates must be 'error', 'drop' or 'keep', not {duplicates!r}")
    return policies[duplicates]()


def day_links(articles: DataFrame) -> DataFrame:
    """Every (symbol, date, position, link): the links of a day in publication order, from 1.

    One row per link, so a day of any size is just many rows.
    """
    slim = articles.select("symbol", "date", "published", "link")
    return (with_position(slim, ["symbol", "date"], ["published", "link"])
            .select("symbol", "date", "position", "link"))


def day_sums(articles: DataFrame) -> DataFrame:
    """What scoring needs of a day's articles: four counters and two sums, no texts, no links.

    ``n_resolved`` counts the articles with a source; only they contribute sentiment.
    """
    sums = [f"{what} FILTER (WHERE source.href IS NOT NULL) AS {name}" for c in CHANNELS
            for what, name in ((f"sum({c}_sentiment)", f"{c}_sum"),
                               (f"count({c}_sentiment)", f"{c}_n"))]
    counters = ["count(*) AS n_links", "count(source.href) AS n_resolved", *sums]
    return (articles.where("date IS NOT NULL").groupBy("symbol", "date")
            .agg(*[F.expr(counter) for counter in counters]))


def trading_days(prices: DataFrame) -> DataFrame:
    """open, close and percent change per price day, NaN as NULL."""
    return (prices.selectExpr("symbol", "date", f"{nan_to_null('open')} AS open",
                              f"{nan_to_null('close')} AS close")
            .selectExpr("*", f"{day_change('open', 'close')} AS change"))


def count_timeline(prices: DataFrame, articles: DataFrame) -> DataFrame:
    """Slim timeline for scoring. Articles of days without a price fall away; price days without
    articles stay, with counters of 0."""
    return (trading_days(prices).join(day_sums(articles), ["symbol", "date"], "left")
            .selectExpr("symbol", "date", "open", "close", "change",
                        *[f"coalesce({c}, 0) AS {c}" for c in COUNTERS]))


def build_timeline(prices: DataFrame, articles: DataFrame) -> DataFrame:
    """Exactly one row per (symbol, price day), with the day's number of links; ``day_links`` has
    the links themselves under the same key."""
    counts = (articles.where("date IS NOT NULL").groupBy("symbol", "date")
              .agg(F.count("*").alias("n_links")))
    return (trading_days(prices).join(counts, ["symbol", "date"], "left").na.fill(0, ["n_links"])
            .select("symbol", "date", "open", "close", "change", "n_links"))


def link_articles(timeline: DataFrame, articles: DataFrame) -> DataFrame:
    """The articles of the timeline's days, resolved to source and sentiments.

    A join on the day, which is what a link stands under: copies of a link stay as many as they are.
    """
    found = articles.selectExpr("symbol", "date", "link", "source.href AS href",
                                *[f"{c}_sentiment" for c in CHANNELS])
    return found.join(timeline.select("symbol", "date"), ["symbol", "date"])
