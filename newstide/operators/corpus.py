"""Statistics over all articles."""

from pyspark.sql import DataFrame, Window, functions as F

from newstide.functions.signals import has_text
from newstide.operators.timeline import drop_duplicate_links

# Size of a sketch of distinct sources (2^12 registers, a standard error of some 1.6 %), and how many
# sources a state of the most frequent ones can count.
SKETCH_LG, TRACKED = 12, 10_000
# Leading hexadecimal digits of the draw by which a symbol is ranked in parts first.
PART_DIGITS = 2


def source_counts(articles: DataFrame) -> DataFrame:
    return (articles.where(F.col("source.href").isNotNull())
            .groupBy(F.col("source.href").alias("href")).agg(F.count("*").alias("n")))


def distinct_sources(articles: DataFrame) -> DataFrame:
    return source_counts(articles).select("href")


def source_weights(articles: DataFrame) -> DataFrame:
    """(n + total) / total per source. The total is summed from the counts, in one value."""
    counts = source_counts(articles)
    total = counts.agg(F.sum("n").cast("double")).scalar()
    return counts.withColumn("weight", (F.col("n") + total) / total)


def top_sources(articles: DataFrame, k: int = 10) -> DataFrame:
    return source_counts(articles).orderBy(F.desc("n"), "href").limit(k)


def corpus_stats(articles: DataFrame) -> DataFrame:
    """Articles, articles with text, distinct sources; a hot source shrinks map-side."""
    return articles.agg(F.count("*").alias("n_articles"),
                        F.expr(f"count_if({has_text('text')}) AS n_with_text"),
                        F.count_distinct("source.href").alias("n_sources"))


def corpus_state(articles: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """What ``corpus_stats_of`` and ``top_sources_of`` need, per symbol: counts, a HyperLogLog sketch
    of the sources, and a state of the most frequent ones. All of it combines map-side and has a
    bounded size, whatever the number of articles; states of any parts of a corpus can be united.
    """
    known = "FILTER (WHERE source.href IS NOT NULL)"
    return articles.groupBy("symbol").agg(
        F.count("*").alias("n_articles"), F.expr(f"count_if({has_text('text')}) AS n_with_text"),
        F.expr(f"hll_sketch_agg(source.href, {SKETCH_LG}) AS sources"),
        F.expr(f"approx_top_k_accumulate(source.href, {tracked}) {known} AS top"))


def corpus_stats_of(state: DataFrame) -> DataFrame:
    """``corpus_stats`` from stored states: counts are exact, the number of sources is estimated."""
    return state.agg(F.coalesce(F.sum("n_articles"), F.lit(0)).alias("n_articles"),
                     F.coalesce(F.sum("n_with_text"), F.lit(0)).alias("n_with_text"),
                     F.expr("hll_sketch_estimate(hll_union_agg(sources)) AS n_sources"))


def top_sources_of(state: DataFrame, k: int = 10, tracked: int = TRACKED) -> DataFrame:
    """``top_sources`` from stored states: exact up to three quarters of ``tracked`` sources, which
    has to be that of the states; beyond, a count errs by 3.5 / ``tracked`` of all articles at most,
    and sources rarer than that can be missing."""
    # by a constant key: without any state there is nothing to estimate from
    found = (state.groupBy(F.lit(0).alias("_all")).agg(
        F.expr(f"approx_top_k_combine(top, {tracked}) AS top"))
        .selectExpr(f"inline(approx_top_k_estimate(top, {tracked}))"))
    return (found.where("item IS NOT NULL").selectExpr("item AS href", "count AS n")
            .orderBy(F.desc("n"), "href").limit(k))


def sample_rank(articles: DataFrame, n: int = 10, seed: int = 42,
                unique: bool = False) -> DataFrame:
    """(symbol, link, rank) of the ``n`` links per symbol that come first in a seeded hash order.

    A symbol with fewer gives all it has. Only keys are ranked, in two steps: within the 256 parts
    of the draw's range first, then what these parts let through. A hot symbol is 256 groups in
    the first step, and at most 256 n rows in the second, whatever the number of map tasks.
    With ``unique`` no symbol has a link twice, and keys need not be made distinct first.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "symbol", "link"))
    keys = articles.select("symbol", "link")
    keys = (keys if unique else keys.distinct()).withColumn("_draw", draw)
    part = Window.partitionBy("symbol", F.substring("_draw", 1, PART_DIGITS))
    order = ["_draw", "link"]
    first = (keys.withColumn("_rank", F.row_number().over(part.orderBy(*order)))
             .where(F.col("_rank") <= n))
    ranked = F.row_number().over(Window.partitionBy("symbol").orderBy(*order))
    return (first.withColumn("rank", ranked).where(F.col("rank") <= n)
            .select("symbol", "link", "rank"))


def sample_articles(articles: DataFrame, n: int = 10, seed: int = 42,
                    unique: bool = False) -> DataFrame:
    """The articles of ``sample_rank``, one per link; whole rows are fetched for these alone."""
    chosen = sample_rank(articles, n, seed, unique).drop("rank")
    rows = articles.join(chosen, ["symbol", "link"], "left_semi").select(*articles.columns)
    return rows if unique else drop_duplicate_links(rows)
