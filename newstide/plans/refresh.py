"""Bring a saved engine up to date with new articles, without rewriting what they do not touch."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from newstide.operators.corpus import corpus_state
from newstide.operators.timeline import count_timeline, day_links, drop_duplicate_links, link_order
from newstide.sources.layout import scratch, written
from newstide.sources.news import project_articles
from newstide.sources.snapshots import CORPUS
from newstide.sources.versions import (DIGEST, Draft, Version, new_version, part_of, row_digest,
                                       version_of)


# Number of a row of the delivery.
ROW = "_number"


def _compared(df: DataFrame, part, *more: str) -> DataFrame:
    """Keys, part and what decides between copies, without texts."""
    order = F.struct(*map(F.expr, link_order(df)), F.col(DIGEST))
    return df.select("symbol", "link", part.alias("part"), order.alias("order"), *more)


def _survivors(new: DataFrame) -> DataFrame:
    """What ``drop_duplicate_links`` keeps of the delivery, without texts."""
    slim = new.select(*[c for c in new.columns if c not in ("title", "text")])
    return drop_duplicate_links(slim, F.col(DIGEST))


def _changes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New rows with a key that no stored row has, or that win over the stored one."""
    old = stored.select("symbol", "link", F.col("order").alias("old"))
    return (new.join(old, ["symbol", "link"], "left").where("old IS NULL OR order < old")
            .select("symbol", "link", "part", ROW, F.col("old").isNotNull().alias("replaces")))


def merge_articles(spark: SparkSession, root: str, articles: DataFrame) -> tuple[Version, list[str]]:
    """Add scored articles to a saved engine as a new version; returns it and the changed parts.

    Of copies of a link the one stays that ``drop_duplicate_links`` keeps of all articles ever
    merged, in any order of merging: saving two overlapping deliveries in turn equals saving both at
    once under the policy 'drop'. Copies within the delivery, and keys of the delivery against those
    of its own parts, are compared by keys and digests, which Spark joins by broadcasting the smaller
    side where it is small enough; texts are read and written for changed parts alone, and shuffled
    once, for the writing. A part without news keeps its files, and
    when there are none no version is written. Links of days and sums of days follow for the
    symbols of changed parts. Uniqueness holds by the choice itself and need not be proved over
    stored rows. Articles without a symbol or a link have no key to merge on and are refused.
    """
    base = version_of(spark, root)
    if base is None or not base.tables.get("articles", {}).get("unique"):
        raise ValueError(f"no saved engine with unique links under {root}")
    layout = base.tables["articles"]["layout"]
    part = part_of(layout)
    with scratch():
        found = project_articles(articles)
        keyless = F.col("symbol").isNull() | F.col("link").isNull()
        found = found.where(F.when(~keyless, F.lit(True)).otherwise(
            F.raise_error(F.lit("an article without a symbol or a link"))))
        new = written(found.withColumns({DIGEST: row_digest(found), "_part": part,
                                         ROW: F.monotonically_increasing_id()}), "delivery")
        with new_version(spark, root) as draft:
            delivered = [row["_part"] for row in new.select("_part").distinct().collect()]
            stored = draft.read("articles", parts=delivered, digest=True)
            changes = written(_changes(_compared(_survivors(new), F.col("_part"), ROW),
                                       _compared(stored, part)), "changes")
            parts = sorted(row["part"] for row in changes.select("part").distinct().collect())
            if parts:
                _rewrite(draft, new, changes, parts)
    return version_of(spark, root), parts


def _rewrite(draft: Draft, new: DataFrame, changes: DataFrame, parts: list[str]) -> None:
    """Changed parts anew, and what hangs on them.

    Rows of the delivery are found by their number. Stored ones go only where they are replaced;
    a table of these keys alone lets Spark see how few they are, and leave texts in place.
    """
    fresh = new.join(changes.select(ROW), ROW, "left_semi").drop("_part", ROW)
    replaced = written(changes.where("replaces").select("symbol", "link"), "replaced")
    kept = draft.read("articles", parts=parts, digest=True).join(
        replaced, ["symbol", "link"], "left_anti")
    draft.replace_parts("articles", kept.unionByName(fresh))
    now = draft.read("articles", parts=parts)
    draft.replace_parts("links", day_links(now))
    if CORPUS in draft.tables:
        draft.replace_parts(CORPUS, corpus_state(now))
    symbols = now.select("symbol").distinct()
    prices = draft.read("prices").join(symbols, "symbol", "left_semi")
    draft.write_clustered("days", count_timeline(prices, now),
                          buckets=draft.base.tables["days"]["buckets"], others=True)
