"""Stored web pages as articles."""

from pyspark.sql import DataFrame, functions as F

from newstide.functions.markup import page_parts
from newstide.functions.signals import source_host


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html",
                  errors: bool = False) -> DataFrame:
    """Replace the markup by ``href``, ``title`` and ``text``; other columns pass through.

    A page that cannot be read has neither title nor text and keeps all else; ``errors`` adds the
    column ``page_error``, which says why, NULL for a page that was read.
    """
    found = ["_parts.title", "_parts.text", *(["_parts.error AS page_error"] if errors else [])]
    return (pages.withColumn("_parts", page_parts(html))
            .selectExpr("*", f"{source_host(url)} AS href", *found)
            .drop(html, "_parts"))


def page_failures(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages that could not be read and all pages, per host: (href, n_pages, n_failed)."""
    return (extract_pages(pages, url, html, errors=True).groupBy("href")
            .agg(F.count("*").alias("n_pages"), F.count("page_error").alias("n_failed")))
